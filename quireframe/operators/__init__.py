"""Operators on regions, text, formulas, tables, publications, telemetry and jobs."""

from . import assembly, contracts, drawing, formulas, jobs, limits, markup, packages, policy, publish, rasters, regions, resolution, stats, telemetry, text, textbook, writer

REGISTRIES = (telemetry.R, jobs.R, regions.R, assembly.R, rasters.R, drawing.R, stats.R, text.R, markup.R, publish.R, contracts.R, resolution.R, limits.R, formulas.R, policy.R, packages.R, textbook.R, writer.R)
