"""caseload: support-desk analytics (tickets and chats) as PySpark DataFrame operators."""

__version__ = "0.1.0"
