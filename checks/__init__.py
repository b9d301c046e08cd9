"""Registered queries over the given tables, with reference SQL."""


def load() -> dict:
    """All checks, in order of registration."""
    from checks import page_checks, record_checks, report_checks, site_checks  # noqa: F401
    from checks.registry import CHECKS

    return CHECKS
