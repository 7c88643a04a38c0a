"""Command line: generate | build | status | query."""

from __future__ import annotations

import argparse
import os
from concurrent.futures import ThreadPoolExecutor

from heron.plans import prompts, providers
from heron.plans.answer import answer
from heron.session import session
from heron.sources.knowledge_base import Store, build, write_markdown
from heron.tables import TABLES, table


#: Pages that are written at a time.
AUTHORS = 8


def table_page(name: str, columns: list[tuple[str, str]], keys: list[tuple[str, str, str]]) -> str:
    """A knowledge-base page of a table, from its schema."""
    lines = ["---", f"name: {name}", f"description: Columns and keys of {name}", "tags: [table]", "priority: medium"]
    if keys:
        lines += ["fk_to:", *[f"  - {{column: {c}, ref_table: {t}, ref_column: {r}}}" for c, t, r in keys]]
    return "\n".join([*lines, "---", "", f"CREATE TABLE {name} ({', '.join(f'{c} {t}' for c, t in columns)})", ""])


def generate(spark, sf_dir: str, root: str, overwrite: bool = False) -> int:
    """Pages for every table of sf_dir; foreign keys follow from names that end alike. How many were written."""
    frames = {t: table(spark, sf_dir, t) for t in TABLES}
    keys = {c.name.split("_", 1)[1]: (t, c.name) for t, df in frames.items() for c in df.schema[:1] if "_" in c.name}

    def page(t: str, df) -> int:
        found = [(c, *keys[c.split("_", 1)[1]]) for c in df.columns[1:] if "_" in c and c.split("_", 1)[1] in keys and keys[c.split("_", 1)[1]][0] != t]
        return write_markdown(f"{root}/ddl/{t}.md", table_page(t, df.dtypes, found), overwrite, spark)

    with ThreadPoolExecutor(AUTHORS) as pool:
        n = sum(pool.map(lambda x: page(*x), frames.items()))
    n += write_markdown(f"{root}/ddl/KB.md", "---\nname: ddl\ndescription: Tables\n---\n\nThe tables of the warehouse.\n", overwrite, spark)
    return n


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["generate", "build", "status", "query"])
    p.add_argument("question", nargs="?", default="")
    p.add_argument("--root", default="knowledge_base")
    p.add_argument("--store", default="knowledge_store")
    p.add_argument("--data", default=os.environ.get("HERON_DATA", "/root/testdata/sf0.01"))
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--dialect", default="spark")
    a = p.parse_args(argv)
    spark = session()
    store = Store(spark, os.path.abspath(a.store))
    if a.command == "generate":
        print(generate(spark, a.data, os.path.abspath(a.root), a.overwrite), "pages written")
    elif a.command == "build":
        print(build(spark, os.path.abspath(a.root), store, providers.HashingEmbedder()))
    elif a.command == "status":
        print(prompts.result_table(store.status()))
    else:
        tables = {t: table(spark, a.data, t) for t in TABLES}
        writer = providers.TemplateWriter("orders", "o_totalprice", "o_custkey", "o_orderdate")
        found = answer(spark, a.question, tables, writer, store if store.current() else None, dialect=a.dialect)
        print(found.sql or found.category, found.error or "", prompts.result_table(found.result) if found.result is not None else "", prompts.as_markdown(found.context.citations) if found.context else "", found.seconds, sep="\n")


if __name__ == "__main__":
    main()
