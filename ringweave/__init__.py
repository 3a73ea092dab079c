"""Pipelines of jobs, rings and frames on Apache Spark."""

from .builder import Work, map
from .config import module_of, register, run, work
from .external import InvokeError, invoke, run_with_stdin
from .plans.nodes import Args, Frame, Job, Module, Multiple, Object, PlanError, Reducer
from .stats import cpu_count
from .sweep import sweep

__all__ = ["Args", "Frame", "InvokeError", "Job", "Module", "Multiple", "Object", "PlanError", "Reducer", "Work", "cpu_count", "invoke", "map", "module_of", "register", "run", "run_with_stdin", "sweep", "work"]
