"""Delivery-address linkage and route analytics on Spark."""
