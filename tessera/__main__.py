"""Command line: ``python -m tessera init|silver|gold|show|stats|detail|health|search|similar|lineage|validate ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import vectors
from tessera.operators import graph, observe, quality, relational, search
from tessera.plans import gold, silver
from tessera.session import session
from tessera.sources import files, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("silver", help="raw objects to entity tables")
    s.add_argument("--path", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--glob")
    g = sub.add_parser("gold", help="entity tables to the graph")
    g.add_argument("--silver", required=True)
    g.add_argument("--out", required=True)
    i = sub.add_parser("init", help="empty tables of every layer, where there are none")
    i.add_argument("--out", required=True)
    w = sub.add_parser("show", help="counts and the latest rows of the entity tables")
    w.add_argument("--silver", required=True)
    w.add_argument("--most", type=int, default=10)
    d = sub.add_parser("detail", help="a node, its edges in both directions and its times")
    d.add_argument("--gold", required=True)
    d.add_argument("id")
    for name in ("stats", "validate", "health"):
        c = sub.add_parser(name)
        c.add_argument("--gold", required=True)
    q = sub.add_parser("search")
    q.add_argument("--gold", required=True)
    q.add_argument("question")
    v = sub.add_parser("similar")
    v.add_argument("--gold", required=True)
    v.add_argument("text")
    lineage = sub.add_parser("lineage")
    lineage.add_argument("--events", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session(master=a.master)
    read = lambda root, name: spark.read.parquet(f"{root}/{name}")
    if a.command == "silver":
        for name, df in silver.run(files.objects(spark, a.path, a.glob)).items():
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    elif a.command == "gold":
        built = gold.build(*(read(a.silver, n) for n in ("documents", "communications", "events")), folder=f"{a.out}/_made")
        for name, df in built.items():
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        gold.chunks(read(a.out, "gold_nodes")).write.mode("overwrite").parquet(f"{a.out}/chunks")
        gold.save({n: read(a.out, n) for n in ("gold_nodes", "gold_edges", "gold_timeline")}, f"{a.out}/store")
    elif a.command == "init":
        for name in schemas.TABLES:
            if not sinks.exists(spark, f"{a.out}/{name}"):
                spark.createDataFrame([], schemas.schema(name)).write.parquet(f"{a.out}/{name}")
            print(name)
    elif a.command == "show":
        latest = {"documents": "created_time", "communications": "received_at", "events": "start_time", "files": "filename"}
        for name, by in latest.items():
            rows = read(a.silver, name)
            print(name, rows.count())
            shown = [c for c in ("id", "title", "subject", "filename", "processing_status", by) if c in rows.columns]
            relational.top(rows.select(*dict.fromkeys(shown)), a.most, F.desc_nulls_last(by), "id").show(truncate=60)
    elif a.command == "detail":
        nodes, edges = read(a.gold, "gold_nodes"), read(a.gold, "gold_edges")
        nodes.filter(F.col("id") == a.id).select("id", "type", "subtype", "name", "status", "importance", "content").show(1, 400, vertical=True)
        near = graph.edge_details(graph.neighbours(edges, a.id), nodes.select("id", "name"))
        near.select("source_name", "predicate", "target_name").orderBy("predicate", "source_name", "target_name").show(100, 80)
        read(a.gold, "gold_timeline").filter(F.col("node_id") == a.id).select("field", "new_value").show()
    elif a.command == "health":
        nodes, edges = read(a.gold, "gold_nodes"), read(a.gold, "gold_edges")
        observe.health(spark, []).show()
        print("nodes", nodes.count(), "edges", edges.count(), "blocked", read(a.gold, "blocked").count())
        relational.missing_rates(nodes, ["content", "embedding_text"]).show()
        for end in ("source_node_id", "target_node_id"):
            quality.integrity(edges, end, nodes, "id").show()
    elif a.command == "stats":
        gold.statistics(read(a.gold, "gold_nodes"), read(a.gold, "gold_edges")).orderBy("what", F.desc("n")).show(100, False)
        relational.missing_rates(read(a.gold, "gold_nodes"), ["content", "embedding_text"]).show()
    elif a.command == "validate":
        quality.embedding_validation(read(a.gold, "gold_nodes"), "embedding_vector", 384).show()
    elif a.command == "search":
        order = [F.desc_nulls_last("importance"), F.asc("name")]
        search.keyword_search(read(a.gold, "gold_nodes"), a.question, ["name", "summary", "content"], order).select("type", "name", "importance").show(truncate=80)
    elif a.command == "similar":
        wanted = spark.range(1).select(vectors.hashed(F.lit(a.text)).alias("v")).first().v
        search.vector_search(read(a.gold, "gold_nodes"), wanted, "embedding_vector", "id").select("score", "type", "name").show(truncate=80)
    else:
        sinks.lineage_counts(spark.read.json(a.events)).show()


if __name__ == "__main__":
    main()
