"""All registered core queries: importing the package registers them."""

from planeframe.plans import checks, codes, files, frames, planes  # noqa: F401
from planeframe.queries import ORACLES, QUERIES  # noqa: F401
