"""tidyloom: clean, profile and split datasets of unknown schema with Spark."""

from tidyloom.config import CleanConfig
from tidyloom.plans.clean import CleanReport, CleanResult, clean
from tidyloom.plans.pipeline import PipelineResult, run_pipeline

__all__ = ["CleanConfig", "CleanReport", "CleanResult", "PipelineResult", "clean", "run_pipeline"]
