"""Domain tables made from the driver's tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINE = {
    "accession": "concat('P', l_partkey)",
    "site": "concat(substr('STY', cast(l_suppkey % 3 as int) + 1, 1), l_linenumber)",
    "sample": "concat('data:', l_returnflag, l_linestatus)",
    "kinase": "concat('K', lpad(cast(l_suppkey % 20 as {text}), 2, '0'))",
}


def _line(*names: str, text: str = "string") -> str:
    return ", ".join(f"{LINE[n].format(text=text)} AS {n}" for n in names)


VIEWS = {
    "tb_raw": "SELECT {line:accession site sample}, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS value FROM lineitem",
    "tb_compendia": "SELECT accession, site, max(n) AS num_compendia FROM (SELECT {line:accession site}, cast((l_partkey + l_linenumber) % 6 as int) AS n FROM lineitem) t GROUP BY accession, site",
    "tb_network": "SELECT DISTINCT cast(l_orderkey % 10 as int) AS network_id, {line:kinase accession site} FROM lineitem",
    "tb_weight": "SELECT accession, site, kinase, avg(l_extendedprice) AS weight FROM (SELECT {line:accession site kinase}, l_extendedprice FROM lineitem) t GROUP BY accession, site, kinase",
    "tb_sequence": "SELECT concat('D', doc_id) AS accession, upper(regexp_replace(text, '[^A-Za-z]', ''{all})) AS sequence, doc_id FROM documents",
    # whole texts as proteins of at most 400 residues
    "tb_protein": "SELECT concat('D', doc_id, '.', part) AS accession, substr(residues, part * 400 + 1, 400) AS sequence, cast(8 + (doc_id * 7 + part) % 97 as int) AS ahead_of FROM (SELECT doc_id, residues, {parts} AS part FROM (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', ''{all})) AS residues FROM documents) t WHERE residues <> '') u",
    "tb_events": "SELECT ts, event_type AS sample, concat('U', user_id) AS accession, concat(substr('STY', cast(length(event_type) % 3 as int) + 1, 1), event_id % 50 + 1) AS site, value FROM events",
}


def _sql(view: str, text: str, all_: str) -> str:
    sql = VIEWS[view].replace("{all}", all_).replace("{parts}", "explode(sequence(0, cast((length(residues) - 1) div 400 as int)))" if text == "string" else "unnest(range(0, (length(residues) - 1) // 400 + 1))")
    while "{line:" in sql:
        head, tail = sql.split("{line:", 1)
        names, rest = tail.split("}", 1)
        sql = head + _line(*names.split(), text=text) + rest
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the driver's table it is made from."""
    sql = _sql(name, "string", "")
    for source in ("lineitem", "documents", "events"):
        if f"FROM {source}" in sql:
            return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))
    raise KeyError(name)


def duck(*names: str) -> str:
    """Common table expressions for DuckDB."""
    return ", ".join(f"{n} AS ({_sql(n, 'VARCHAR', ', ' + repr('g'))})" for n in names)
