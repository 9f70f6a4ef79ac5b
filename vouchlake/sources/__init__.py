"""Sources and sinks: files, documents, workbooks, result files."""
