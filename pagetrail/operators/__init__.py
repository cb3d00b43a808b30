"""DataFrame operators: extraction, resolution, assessment, remediation, verification, reports."""
