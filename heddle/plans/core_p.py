"""Queries of problem 2 (hierarchies) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.operators import hierarchy as h
from heddle.session import keep, table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_nodes", "node_id", "parent_node_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return h.find_cycles(_links(spark, d))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root, number of descendants and cycle mark of each node."""
    tree = keep(h.hierarchy(_links(spark, d)), "tree")
    below = h.descendants(tree).groupBy("ancestor_id").agg(F.count("*").alias("n_descendants"))
    return tree.join(below, tree.node_id == below.ancestor_id, "left").select(
        "node_id", "parent_node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"),
        F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants"), "on_cycle", "cycle_head",
    )


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return h.descendants(h.hierarchy(_links(spark, d)))


_WALK = """
links as (select node_id as id, min(parent_node_id) as parent from code_nodes where node_id is not null group by 1),
known as (select l.id, k.id as parent from links l left join links k on l.parent = k.id),
walk as (
  select id, 0 as depth, id as root, [id] as path from known where parent is null
  union all
  select k.id, w.depth + 1, w.root, list_append(w.path, k.id) from walk w join known k on k.parent = w.id),
rest as (select * from known where id not in (select id from walk)),
climb as (
  select id as start, parent as cur, [id] as seen, id = parent as closed from rest
  union all
  select c.start, r.parent, list_append(c.seen, c.cur), r.parent = c.start
  from climb c join rest r on r.id = c.cur where c.cur <> c.start and not list_contains(c.seen, c.cur)),
heads as (select start as id, list_min(seen) as cycle_head from climb where cur = start)
"""

QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants}

ORACLE = {
    "p2_found": f"with recursive {_WALK} select id as node_id, cycle_head from heads",
    "p2_hierarchy": f"""with recursive {_WALK},
below as (select a as id, count(*) as n from (select unnest(path[1:depth]) as a from walk where depth > 0) group by 1)
select w.id as node_id, case when w.depth > 0 then w.path[w.depth] end as parent_node_id, w.root as root_id,
  w.depth as depth, array_to_string(w.path, ' > ') as path, coalesce(b.n, 0)::bigint as n_descendants,
  false as on_cycle, null::varchar as cycle_head
from walk w left join below b on b.id = w.id
union all
select r.id, r.parent, null, null, null, 0::bigint, h.cycle_head is not null, h.cycle_head
from rest r left join heads h on h.id = r.id""",
    "p2_descendants": f"""with recursive {_WALK}
select path[i] as ancestor_id, id as node_id, (depth - i + 1)::int as distance
from (select id, depth, path, unnest(range(1, depth + 1)) as i from walk where depth > 0)""",
}
