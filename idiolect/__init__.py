"""Stylometry over text tables, Spark first."""

from idiolect.operators.features import analyse, features
from idiolect.operators.profile import VERSION as SCHEMA_VERSION
from idiolect.operators.profile import build as build_profile
from idiolect.operators.profile import score_groups
from idiolect.operators.render import instructions as render_instructions
from idiolect.operators.render import summary as render_summary
from idiolect.operators.scoring import DIMENSIONS
from idiolect.operators.scoring import NAMES as DIMENSION_NAMES
from idiolect.sources.store import Store

__version__ = "0.2.0"
__all__ = ["DIMENSIONS", "DIMENSION_NAMES", "SCHEMA_VERSION", "Store", "__version__", "analyse", "build_profile", "features", "render_instructions", "render_summary", "score_groups"]
