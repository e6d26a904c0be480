import random
from collections import Counter
from datetime import datetime

import pytest

from regspark.plans.live import BASE, LiveStudy
from regspark.session import fresh_path


def batch(draw):
    """Rows of the base tables, with keys that come back in later batches."""
    tags = [(draw.randrange(12), 1, draw.choice([None, datetime(2024, draw.randint(1, 4), 2)]),
             draw.choice([None, " ", "active", "stale"])) for _ in range(10)]
    links = [(draw.randrange(8), draw.randrange(9)) for _ in range(12)]
    found = [(draw.randrange(8), draw.choice("fg"), draw.randrange(2), draw.choice("stuv"),
              draw.choice([None, "", ".a", ".b"])) for _ in range(14)]
    return {"tags": tags, "repo_layers": links, "occurrences": found}


def frames(spark, rows):
    return {name: spark.createDataFrame([(*r, i) for i, r in enumerate(given)], BASE[name][0] + ", seq int")
            for name, given in rows.items()}


def expected(batches):
    tags, found, links = {}, {}, set()
    for b in batches:
        tags.update({t[0]: t for t in b["tags"]})
        links.update(b["repo_layers"])
        found.update({r[:3]: r for r in b["occurrences"]})
    named = lambda v: v if v and v.strip() else "unknown"
    out = {("month_histogram", k, "count"): n for k, n in Counter(
        t[2].strftime("%Y-%m") for t in tags.values() if t[2]).items()}
    out |= {("status_histogram", k, "count"): n for k, n in Counter(named(t[3]) for t in tags.values()).items()}
    out |= {("filetype_frequency", k, "n"): n for k, n in Counter(named(r[4]) for r in found.values()).items()}
    out |= {("layer_uniqueness", str(k), "is_unique"): int(n == 1) for k, n in Counter(a for a, _ in links).items()}
    reach = {(r[3], layer, repo) for r in found.values() for layer, repo in links if layer == r[0]}
    secrets = {s for s, _, _ in reach}
    repos = {s: len({r for t, _, r in reach if t == s}) for s in secrets}
    out |= {("repos_per_secret", s, "repo_count"): n for s, n in repos.items()}
    out |= {("repos_per_secret", s, "layer_count"): len({a for t, a, _ in reach if t == s}) for s in secrets}
    return out | {("secret_count_distribution", str(k), "secret_count"): n for k, n in Counter(repos.values()).items()}


def shown(study):
    rows = study.shown().collect()
    assert len({r[:3] for r in rows}) == len(rows)
    return {tuple(r[:3]): r.value for r in rows}


def test_three_batches_equal_a_full_computation(spark, monkeypatch):
    draw = random.Random(3)
    given = [batch(draw) for _ in range(3)]
    study = LiveStudy(spark, fresh_path(spark, "live"), buckets=2)
    study.apply(0, "seq", **frames(spark, given[0]))
    assert shown(study) == expected(given[:1])

    # the second batch dies on its way through the study tables, and is repeated
    with monkeypatch.context() as patched:
        patched.setattr(study, "_count_reach", lambda: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            study.apply(1, "seq", **frames(spark, given[1]))
    study.apply(1, "seq", **frames(spark, given[1]))
    assert shown(study) == expected(given[:2])

    # a batch with rows of one table only; others stay at their versions
    only = {"occurrences": given[2]["occurrences"]}
    study.apply(2, "seq", **frames(spark, only))
    assert shown(study) == expected([*given[:2], {"tags": [], "repo_layers": [], **only}])

    versions = {name: table.version() for name, table in study.tables.items()}
    study.apply(2, "seq", **frames(spark, only))
    assert versions == {name: table.version() for name, table in study.tables.items()}
