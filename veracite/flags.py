"""Flags of a run and the names of the files beside a document."""

from __future__ import annotations

from pathlib import PurePosixPath

# The flags that a run knows.
FLAGS = ("--json", "--rules", "--identity", "--fail-on-unreachable", "--allow-unclaimed", "--explain-fetch", "--no-archive", "--fail-on-gone", "--help")


def unknown_flag(args: list[str]) -> str | None:
    """The first flag that no run knows."""
    return next((a for a in args if a.startswith("--") and a not in FLAGS), None)


def failing(args: list[str]) -> dict[str, bool]:
    """What besides an unsupported claim fails a check, as arguments of ``run_exit``."""
    return {"fail_on_unreachable": "--fail-on-unreachable" in args, "fail_on_unclaimed": "--allow-unclaimed" not in args}


def beside(document: str, kind: str) -> str:
    """The path of a document's ``claims.json``, ``claims.draft.json``, ``evidence.json`` or ``archive``."""
    path = PurePosixPath(document)
    return str(path.with_name(f"{path.stem if path.suffix not in ('', '.') else path.name}.{kind}"))
