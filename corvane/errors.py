"""Typed errors: every refusal names what was wrong."""


class CorvaneError(Exception):
    """Base of all errors of this package."""


class QueryError(CorvaneError, ValueError):
    """A query vector or k that cannot be answered: empty, wrong dimension, not finite, zero, or k < 1."""


class ValidationError(CorvaneError, ValueError):
    """Rows or metadata that break a rule of the store."""


class ManifestError(ValidationError):
    """A manifest that is inconsistent or not supported."""


class ModelMismatch(CorvaneError):
    """A query's model is not the corpus's model."""


class SpecError(CorvaneError, ValueError):
    """A build specification with a missing, unknown or contradictory setting."""


class NotIndexed(CorvaneError):
    """A feature that this corpus does not carry: an unknown space, or a blob whose bytes are not stored."""


class CitationError(CorvaneError, LookupError):
    """A citation that does not resolve in this corpus."""
