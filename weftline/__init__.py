"""Exploratory analytics with lineage, on Spark DataFrames."""

from weftline.plans.workspace import Workspace
from weftline.session import build_session

__all__ = ["Workspace", "build_session"]
