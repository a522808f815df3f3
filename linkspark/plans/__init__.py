"""Whole plans: from dumps to linked documents, and the driver's queries."""
