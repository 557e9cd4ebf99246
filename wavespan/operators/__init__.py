"""DataFrame-to-DataFrame operators; column names are always parameters."""

INTENDED = "intended"
AS_CODED = "as_coded"


def check_semantics(semantics: str) -> bool:
    """Validate the flag and tell whether the literal ("as coded") reading is wanted."""
    if semantics not in (INTENDED, AS_CODED):
        raise ValueError(f"semantics must be {INTENDED!r} or {AS_CODED!r}, got {semantics!r}")
    return semantics == AS_CODED
