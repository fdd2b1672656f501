"""Rule-based, recursive and graph analytics on Spark."""

__all__ = ["Session"]


def __getattr__(name: str):
    if name == "Session":
        from spindrel.session import Session

        return Session
    raise AttributeError(name)
