"""Spatial neighbourhood analytics as Spark plans."""
