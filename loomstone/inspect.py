"""Looking at a version store: ``python -m loomstone.inspect ROOT KEY COMMAND [ARGUMENTS]``.

    roots                    refs and their versions
    stats VERSION            rows, segments, bytes of text of the version file
    walk VERSION             segments in key order
    compare OLD NEW          segments that both have, and that only one has
    changed OLD NEW VALUE    keys that differ, by kind
    verify                   every version's digest against its rows
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from loomstone.sources.store import VersionStore


def roots(store: VersionStore) -> list[tuple[str, str]]:
    """(name, version) of every ref."""
    return list(store.refs().items())


def stats(store: VersionStore, version_id: str) -> dict:
    """Counts of a version, from its file alone."""
    version = store.version(version_id)
    sizes = [s.n_rows for s in version.segments]
    return {
        "n_rows": version.n_rows, "n_segments": len(sizes), "least_rows": min(sizes, default=0), "most_rows": max(sizes, default=0),
        "fill": version.n_rows / (len(sizes) * max(sizes)) if sizes and max(sizes) else 0.0, "generation": version.generation, "parents": list(version.parents),
    }


def walk(store: VersionStore, version_id: str) -> list[tuple]:
    """(place, least key, greatest key, rows, digest) of the segments in key order."""
    return [(n, s.low, s.high, s.n_rows, s.digest) for n, s in enumerate(store.version(version_id).segments)]


def to_text(store: VersionStore, version_id: str) -> str:
    """The version as an outline: its own line, then one for each segment."""
    version = store.version(version_id)
    lines = [f"version {version.id[:12]} rows {version.n_rows} generation {version.generation}"]
    return "\n".join(lines + [f"  [{low} .. {high}] rows {n} digest {digest[:12]}" for _, low, high, n, digest in walk(store, version_id)])


def compare(store: VersionStore, old: str, new: str) -> dict[str, int]:
    """Segments that two versions share, and that only one has."""
    a, b = ({s.content for s in store.version(v).segments} for v in (old, new))
    return {"shared": len(a & b), "only_old": len(a - b), "only_new": len(b - a)}


def changed(store: VersionStore, old: str, new: str, value: str) -> DataFrame:
    """Keys that differ between two versions."""
    return store.diff(old, new, value)


def verify(store: VersionStore) -> list[str]:
    """Versions whose rows don't give their digest."""
    return [v.id for v in store.versions() if not store._same(store.snapshot(v.id), v)]


def changed_spans(store: VersionStore, old: str, new: str) -> list[tuple[str | None, str | None]]:
    """Key spans outside of which two versions are the same: a hint that is read from version files alone."""
    a, b = store.version(old), store.version(new)
    shared = {s.content for s in a.segments} & {s.content for s in b.segments}
    return sorted({(s.low, s.high) for v in (a, b) for s in v.segments if s.content not in shared}, key=repr)


def cache_usage(spark: SparkSession) -> list[tuple[str, int, int]]:
    """(name, bytes in memory, bytes on disk) of what sessions keep on the cluster."""
    return [(r.name(), r.memSize(), r.diskSize()) for r in spark.sparkContext._jsc.sc().getRDDStorageInfo()]


def main(arguments: list[str]) -> int:
    root, key, command, *rest = arguments
    store = VersionStore(SparkSession.builder.getOrCreate(), root, key)
    if command == "roots":
        print("\n".join(f"{name}\t{version}" for name, version in roots(store)))
    elif command == "stats":
        print("\n".join(f"{name}\t{value}" for name, value in stats(store, *rest).items()))
    elif command == "walk":
        print(to_text(store, *rest))
    elif command == "compare":
        print("\n".join(f"{name}\t{value}" for name, value in compare(store, *rest).items()))
    elif command == "changed":
        changed(store, *rest).show(1000, truncate=False)
    elif command == "verify":
        bad = verify(store)
        print("\n".join(bad) or "all versions are whole")
        return int(bool(bad))
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
