"""Quotation verification and text-corpus operators, planned natively on Spark."""
