"""Coupon-ledger audit, repair, allocation and reporting as Spark jobs."""
