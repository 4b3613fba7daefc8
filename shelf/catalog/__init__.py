"""Every registered query with its SQL counterpart."""

from shelf.catalog import crop, files, locate, logs, names, raster, similar, streams  # noqa: F401
from shelf.fixtures import ORACLES, QUERIES  # noqa: F401
