"""Named queries over the operators, their fixtures and their SQL equivalents."""

from . import bands, classes, derived, extend, files, geo, patches, rasters, registry, scene, training  # noqa: F401
