"""All queries of the library: importing the modules registers them."""

from __future__ import annotations

from heron.operators import ann, knowledge, relational, resolution, retrieval, statements
from heron.operators.catalogue import COVERS, ORACLE_SQL, QUERIES
from heron.streaming import windows

__all__ = ["COVERS", "ORACLE_SQL", "QUERIES", "ann", "knowledge", "relational", "resolution", "retrieval", "statements", "windows"]
