"""Registry of the runnable queries and the SQL each one is held against."""

from seqforge.plans import chunks, degradations, files, frames, render, runs, sequences

QUERIES: dict = {**frames.QUERIES, **chunks.QUERIES, **degradations.QUERIES, **sequences.QUERIES, **render.QUERIES, **files.QUERIES, **runs.QUERIES}
ORACLES: dict[str, str] = {**frames.ORACLES, **chunks.ORACLES, **degradations.ORACLES, **sequences.ORACLES, **render.ORACLES, **files.ORACLES, **runs.ORACLES}
