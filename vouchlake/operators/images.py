"""Image clean-up before OCR. Needs OpenCV; without it images pass unchanged."""

from __future__ import annotations

import numpy as np

from ..config import CONFIG

try:
    import cv2
except ImportError:
    cv2 = None


def skew_angle(angles: np.ndarray, least: float = CONFIG.deskew_min_angle, most: float = CONFIG.deskew_max_angle) -> float:
    """The median of the near-horizontal line angles (below ``most``); 0 if there are none or it is below ``least``."""
    near = angles[np.abs(angles) < most]
    angle = float(np.median(near)) if len(near) else 0.0
    return 0.0 if abs(angle) < least else angle


def line_angles(points: np.ndarray) -> np.ndarray:
    """Angles in degrees of line segments (x1, y1, x2, y2)."""
    return np.degrees(np.arctan2(points[:, 3] - points[:, 1], points[:, 2] - points[:, 0]))


def clean_image(image: np.ndarray) -> np.ndarray:
    """Gray, straightened, denoised, contrast-limited equalisation, binarised, closed. Gray weighs the channels in the order blue, green, red, whichever they are: results depend on it."""
    if cv2 is None:
        return image
    gray = cv2.cvtColor(image, cv2.COLOR_BGR2GRAY) if image.ndim == 3 else image
    found = cv2.HoughLinesP(cv2.Canny(gray, 50, 150), 1, np.pi / 180, 100, minLineLength=gray.shape[1] // 4, maxLineGap=10)
    angle = skew_angle(line_angles(found[:, 0, :].astype(float))) if found is not None else 0.0
    if angle:
        h, w = gray.shape
        gray = cv2.warpAffine(gray, cv2.getRotationMatrix2D((w // 2, h // 2), angle, 1.0), (w, h), flags=cv2.INTER_CUBIC, borderMode=cv2.BORDER_REPLICATE)
    gray = cv2.fastNlMeansDenoising(gray, h=CONFIG.denoise_strength)
    gray = cv2.createCLAHE(CONFIG.clahe_clip, (8, 8)).apply(gray)
    gray = cv2.adaptiveThreshold(gray, 255, cv2.ADAPTIVE_THRESH_GAUSSIAN_C, cv2.THRESH_BINARY, 11, 2)
    return cv2.morphologyEx(gray, cv2.MORPH_CLOSE, np.ones((2, 2), np.uint8))
