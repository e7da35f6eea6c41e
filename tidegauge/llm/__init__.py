"""Operators for large text corpora: filters, scorers, near-duplicate joins, mixing. Nothing else imports this package."""
