"""Versioned tables on Spark: commit, log, diff, checkout, snapshot."""

from palimpsest.operators.identity import ContentMatchIdentity, IdentityStrategy, PrimaryKeyIdentity
from palimpsest.repository import CommitResult, DiffResult, Repository
from palimpsest.sources.files import StoreError
from palimpsest.sources.workspace import ship

__version__ = "0.1.0"
__all__ = ["CommitResult", "ContentMatchIdentity", "DiffResult", "IdentityStrategy", "PrimaryKeyIdentity", "Repository", "StoreError", "__version__", "ship"]
