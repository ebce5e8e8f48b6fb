"""Spark operators for genetics and drug-target data releases."""

from locusforge.session import build_session, cut_lineage, scratch_path, ship_package

__all__ = ["build_session", "cut_lineage", "scratch_path", "ship_package"]
