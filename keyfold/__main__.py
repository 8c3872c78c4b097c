"""Commands from standard input, a line each: ``python -m keyfold [folder]``; or
``python -m keyfold migrate FOLDER TARGET [PREFIX]``, which moves a keyspace's values to a table."""

from __future__ import annotations

import shlex
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.engine import KINDS, CommandError, Engine
from keyfold.session import session
from keyfold.sources.storage import migrate_to, migration_stats


def typed_tables(engine: Engine) -> dict[str, DataFrame]:
    """(key, field, value) of each type; a sorted set's scores and a list's places stand in for values
    and fields that they lack."""
    value = F.coalesce("value", F.col("num").cast("string")).alias("value")
    return {name: engine.keys.state(kind).select("key", "field", value) for name, kind in KINDS.items()}


def migrate(folder: str, target: str, prefix: str = "") -> dict[str, int]:
    """Rows moved by type."""
    engine = Engine(session("local[*]"), folder)
    return {r["type"]: r["n_rows"] for r in migration_stats(migrate_to(target, typed_tables(engine), prefix=prefix)).collect()}


def main(args: list[str]) -> None:
    if args and args[0] == "migrate":
        for kind, n in sorted(migrate(*args[1:]).items()):
            print(kind, n)
        return
    engine = Engine(session("local[*]"), args[0] if args else None)
    for line in sys.stdin:
        if words := shlex.split(line):
            try:
                print(engine.execute(*words))
            except CommandError as e:
                print(e)
    engine.keys.flush()


if __name__ == "__main__":
    main(sys.argv[1:])
