from datetime import UTC, datetime, timedelta

import pytest

from wayfarer.plans import schemas
from wayfarer.streaming import sessions as streams

T0 = datetime(2026, 1, 5, 9, 0, tzinfo=UTC)


def names(ddl):
    """Column names of a DDL string; commas inside <> or () don't separate."""
    found, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            found.append(ddl[start:i].split()[0])
            start = i + 1
    return found


@pytest.fixture(scope="session")
def make(spark):
    """make(name, rows): a logical table of dicts, other columns null; minutes after T0 for numbers in time columns."""

    def table(name, rows):
        ddl = getattr(schemas, name.upper())
        if any("engaged_ms" in r for r in rows):
            ddl += ", engaged_ms bigint"
        columns = names(ddl)
        times = {c for c in columns if c.endswith("_at")}

        def value(r, c):
            v = r.get(c, schemas.DEFAULT_WORKSPACE if c == "workspace_id" else None)
            return T0 + timedelta(minutes=v) if c in times and isinstance(v, int | float) else v

        return spark.createDataFrame([tuple(value(r, c) for c in columns) for r in rows], ddl)

    return table


@pytest.fixture
def keyed_state(spark):
    """The state store for lists and timers, for one test."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    streams.use_keyed_state(spark)
    yield
    spark.conf.set(name, before)
