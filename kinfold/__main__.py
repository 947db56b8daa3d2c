"""Command line: python -m kinfold {backfill,sync,rebuild-profiles,rebuild-aliases,search} --hub FOLDER [--source FOLDER]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinfold.config import ResolutionConfig
from kinfold.operators import materialize, search
from kinfold.plans.pipeline import Hub, backfill, rebuild_profiles
from kinfold.sources.tables import TableConnector, parquet_reader
from kinfold.store import Store, replace_range
from kinfold.streaming.sync import sync


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="kinfold")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("backfill", "sync", "rebuild-profiles", "rebuild-aliases", "search"):
        c = commands.add_parser(name)
        c.add_argument("--hub", required=True)
        if name in ("backfill", "sync"):
            c.add_argument("--source", required=True, help="folder of Parquet tables")
            c.add_argument("--system", default="local_employees")
            c.add_argument("--built-at")
        if name.startswith("rebuild"):
            c.add_argument("--identity", type=int)
        if name == "rebuild-aliases":
            c.add_argument("--from-id", type=int)
            c.add_argument("--to-id", type=int)
            c.add_argument("--verify", action="store_true")
        if name == "search":
            c.add_argument("last_name")
            c.add_argument("first_name", nargs="?")
            c.add_argument("--page", type=int, default=1)
            c.add_argument("--per-page", type=int, default=25)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command; the lines that it prints."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kinfold").getOrCreate()
    store, lines = Store(spark, args.hub), []
    if args.command in ("backfill", "sync"):
        source = TableConnector(parquet_reader(spark, args.source), args.system, excluded_codes=ResolutionConfig().rollup_excluded_codes)
        hub = backfill(spark, source, built_at=args.built_at, store=store) if args.command == "backfill" else sync(store, source, built_at=args.built_at)
        lines += [f"{t}: {getattr(hub, t).count()}" for t in ("links", "identities", "credentials", "exclusions", "profiles", "aliases")]
        return _print(lines)
    hub = Hub.load(store)
    if args.command == "rebuild-profiles":
        if args.identity is None:
            store.write("profiles", rebuild_profiles(hub))
        else:
            new = rebuild_profiles(hub, ids=hub.identities.where(F.col("identity_id") == args.identity))
            store.write("profiles", replace_range(hub.profiles, new, "identity_id", args.identity, args.identity + 1))
        lines.append(f"profiles: {store.read('profiles').count()}")
    elif args.command == "rebuild-aliases":
        if args.verify:
            row = materialize.alias_coverage(hub.aliases, hub.staged, hub.links).first()
            lines.append(f"indexed {row['indexed']} of {row['expected']} identities with an alias surname")
        else:
            low = args.identity if args.identity is not None else args.from_id
            high = args.identity + 1 if args.identity is not None else args.to_id
            new = materialize.alias_index(hub.staged, hub.links, low, high)
            whole = low is None and high is None
            store.write("aliases", new if whole else replace_range(hub.aliases, new, "identity_id", low if low is not None else -(1 << 62), high if high is not None else 1 << 62))
            lines.append(f"aliases: {store.read('aliases').count()}")
    else:
        page = search.search(hub.profiles, hub.aliases, args.last_name, args.first_name, args.page, args.per_page)
        lines += page.rows.toJSON().collect()  # a page at most
        lines.append(f"page {page.page} of {page.last_page}, {page.total} found")
    return _print(lines)


def _print(lines: list[str]) -> list[str]:
    for line in lines:
        print(line)
    return lines


if __name__ == "__main__":
    main()
