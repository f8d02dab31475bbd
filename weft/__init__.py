"""weft: declarative enrichment rules, compiled to Spark DataFrames."""

from weft.engine import Engine
from weft.errors import ProjectError
from weft.model import Project
from weft.sources.project_files import load

__all__ = ["Engine", "Project", "ProjectError", "load"]
