"""Constants of the audit model: tolerances, keyword lists, layouts. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class AuditConfig:
    # pages and OCR
    image_dpi: int = 300
    ocr_language: str = "chi_sim+eng"
    ocr_modes: tuple[int, ...] = (6, 3, 11)
    ocr_good_enough: float = 0.50
    ocr_warn_below: float = 0.40
    native_min_chars: int = 50
    native_min_cjk: int = 30
    scanned_image_ratio: float = 0.30
    empty_max_chars: int = 10
    empty_max_cjk: int = 5
    # tables
    row_tolerance: float = 5.0
    column_grid: float = 15.0
    column_reach: float = 50.0
    table_snap: int = 3
    table_join: int = 3
    positional_confidence: float = 0.6
    # image clean-up
    denoise_strength: int = 7
    clahe_clip: float = 3.0
    deskew_max_angle: float = 15.0
    deskew_min_angle: float = 0.3
    # revenue checks
    amount_tolerance: Decimal = Decimal("1.00")
    tax_rate: Decimal = Decimal("1.13")
    # document types by words of the file name, in order of precedence
    type_keywords: tuple[tuple[str, tuple[str, ...]], ...] = field(
        default=(
            ("contract", ("合同", "订单", "采购", "销售")),
            ("receipt", ("回签联", "送货单", "出库单", "签收")),
            ("authorization", ("授权书", "授权")),
            ("reconciliation", ("对账单",)),
        )
    )
    type_labels: tuple[tuple[str, str], ...] = (("contract", "合同"), ("receipt", "回签联"), ("reconciliation", "对账单"), ("authorization", "授权书"))
    extraction_confidence: float = 0.8


CONFIG = AuditConfig()

#: Sheet columns A to AC, in order; the first 17 are inputs.
SHEET_COLUMNS = (
    "year", "month", "customer", "product_category", "order_date", "order_no", "material_name", "spec_model", "delivery_no", "delivery_date", "material_code",
    "delivery_qty", "unit_price", "revenue_tax", "confirm_date", "voucher_no", "revenue_notax",
    "logistics_company", "logistics_no", "logistics_sign_date", "customer_sign_date", "signer", "check1", "check2", "check3", "check4", "check5", "attachment_index", "attachment_result",
)
INPUT_COLUMNS = SHEET_COLUMNS[:17]
#: The first row of data of a sheet (row 2 has the headers).
DATA_ROW = 3
#: Group attributes: a word that their header contains, and the position that counts if no header does.
HINTS = {
    "delivery_no": ("出库单号", 8),
    "customer": ("客户名称", 2),
    "material_name": ("物料名称", 6),
    "spec_model": ("规格型号", 7),
    "unit_price": ("产品单价", 12),
    "revenue_tax": ("含税收入", 13),
    "revenue_notax": ("不含税收入", 16),
    "delivery_date": ("出库日期", 9),
    "confirm_date": ("日期", 14),
}
#: Attributes whose word also stands in other attributes' headers.
COLLIDING = ("revenue_tax", "confirm_date")
#: Interface texts by key: Chinese, English.
TEXTS = {
    "app_title": ("收入细节测试核查系统", "Revenue Detail Testing System"),
    "upload_excel": ("上传Excel细节测试样本", "Upload Excel Detail Test Sample"),
    "upload_folder": ("上传佐证文件（PDF）", "Upload Supporting Documents (PDF)"),
    "start_processing": ("开始处理", "Start Processing"),
    "processing": ("正在处理...", "Processing..."),
    "run_test": ("执行五项核查", "Run 5 Verifications"),
    "export_report": ("导出核查结果", "Export Results"),
    "download_excel": ("下载已填写的Excel", "Download Completed Excel"),
    "summary": ("核查汇总", "Summary"),
    "detail": ("核查明细", "Detail"),
    "language_switch": ("English", "中文"),
    "sidebar_title": ("控制面板", "Control Panel"),
    "step1": ("步骤1: 上传Excel样本", "Step 1: Upload Excel Sample"),
    "step2": ("步骤2: 上传佐证文件", "Step 2: Upload Documents"),
    "step3": ("步骤3: 执行核查", "Step 3: Run Verification"),
    "step4": ("步骤4: 查看结果并导出", "Step 4: Review & Export"),
    "check1": ("①系统信息与合同/订单一致性", "①System vs Contract Consistency"),
    "check2": ("②出库单信息一致性", "②Delivery Note Consistency"),
    "check3": ("③收入确认金额准确性", "③Revenue Amount Accuracy"),
    "check4": ("④收入确认时点合规性", "④Revenue Timing Compliance"),
    "check5": ("⑤签收人员授权验证", "⑤Signer Authorization"),
    "matched": ("已匹配", "Matched"),
    "unmatched": ("未匹配", "Unmatched"),
}
