"""auditloom: document-audit analytics as PySpark DataFrame operators."""
