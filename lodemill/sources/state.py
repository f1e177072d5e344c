"""Small state of the driver: portable JSON files and the versions of an SQLite file."""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
from pathlib import Path


def inside(root: str, name: str) -> Path:
    """The path of a name below a root, links followed; a name that leaves the root is refused."""
    base = Path(root).resolve()
    path = (base / name).resolve()
    if base != path and base not in path.parents:
        raise ValueError(f"{name} is outside the root")
    return path


def export_state(state: dict, root: str, name: str) -> Path:
    """Writes a state as JSON with sorted keys, whole or not at all."""
    path = inside(root, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, held = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(state, out, sort_keys=True)
            out.flush()
            os.fsync(out.fileno())
        os.replace(held, path)
    except BaseException:
        Path(held).unlink(missing_ok=True)
        raise
    return path


def import_state(root: str, name: str) -> dict:
    state = json.loads(inside(root, name).read_text(encoding="utf-8"))
    if not isinstance(state, dict):
        raise ValueError(f"{name} holds no state")
    return state


def migrate(path: str, steps: list[tuple[int, str]], upto: int | None = None) -> list[int]:
    """Runs the steps of an SQLite file that it has not had, in order of their numbers, each in a transaction of its own; gives those run.

    A failing step leaves the file at the step before it. Numbers must be distinct and above 0.
    """
    numbers = [n for n, _ in steps]
    if len(set(numbers)) != len(numbers) or any(n <= 0 for n in numbers):
        raise ValueError("steps need distinct numbers above 0")
    done = []
    db = sqlite3.connect(path, isolation_level=None)
    try:
        db.execute("PRAGMA foreign_keys = ON")
        at = db.execute("PRAGMA user_version").fetchone()[0]
        for number, script in sorted(steps):
            if number <= at or (upto is not None and number > upto):
                continue
            db.execute("BEGIN IMMEDIATE")
            try:
                for statement in filter(str.strip, script.split(";")):
                    db.execute(statement)
                db.execute(f"PRAGMA user_version = {int(number)}")
                db.execute("COMMIT")
            except BaseException:
                db.execute("ROLLBACK")
                raise
            done.append(number)
    finally:
        db.close()
    return done
