"""bookdesk: booking, refund and support-desk analytics as Spark set operators."""

__version__ = "0.1.0"
