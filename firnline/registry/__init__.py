"""All named queries. Importing this package registers them."""

from firnline.registry import analyses, fits, observations, spatial, tables  # noqa: F401
from firnline.registry.base import CHECKS, QUERIES  # noqa: F401
