"""A store of pruned networks and of random experiments over them.

Each write goes to a part folder of its own and counts only once the manifest lists it, which is written
last; so an interrupted write leaves nothing that is read, and a build taken up again adds what is missing
and nothing twice. Every network has its hash in the manifest; random experiments carry the hash of the
network they were made on and are refused where it differs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.networks import network_hash
from ..params import Params
from .readers import RUN_FIELDS

ENTRY = "part string, network_id int, hash string, mix string, size int"
NETWORKS = "network_id int, kinase string, accession string, site string"
NULLS = "mix string, size int, network_id int, network_hash string, kinase string, sample string, rep int, frequency long, p double"


class NetworkStore:
    """The store below a folder, which need not exist."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def manifest(self, kind: str) -> DataFrame:
        """(part, network_id, hash, mix, size) of what counts, `kind` being networks or nulls; mix and size are null for networks."""
        if not self._exists(f"manifest/{kind}"):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/manifest/{kind}")

    def _commit(self, kind: str, entries: DataFrame) -> None:
        entries.selectExpr("part", "network_id", "hash", "mix", "size").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest/{kind}")

    def _parts(self, kind: str, schema: str) -> DataFrame:
        # one row for each write
        parts = [r[0] for r in self.manifest(kind).select("part").distinct().collect()]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{kind}/{p}" for p in parts))

    def networks(self, check: bool = True) -> DataFrame:
        """The networks; an error if one does not have the hash it was stored with."""
        found = self._parts("networks", NETWORKS)
        if check:
            now = network_hash(found).withColumnRenamed("hash", "now")
            if self.manifest("networks").join(now, "network_id", "full_outer").where("hash is null or now is null or hash <> now").take(1):
                raise ValueError(f"a network below {self.folder} is not the one that was stored")
        return found

    def add_networks(self, networks: DataFrame) -> None:
        """Networks under ids that the store does not have."""
        known = self.manifest("networks").select("network_id").distinct()
        if networks.select("network_id").distinct().join(known, "network_id", "left_semi").take(1):
            raise ValueError("the store has a network of this id")
        part = uuid.uuid4().hex
        networks.select(*(c.split()[0] for c in NETWORKS.split(", "))).write.parquet(f"{self.folder}/networks/{part}")
        written = self.spark.read.schema(NETWORKS).parquet(f"{self.folder}/networks/{part}")
        self._commit("networks", network_hash(written).selectExpr(f"'{part}' AS part", "network_id", "hash", "cast(null as string) AS mix", "cast(null as int) AS size"))

    def nulls(self, networks: DataFrame | None = None) -> DataFrame:
        """Stored random experiments; those over `networks` (the store's own by default), refused if they were made on others of the same id."""
        found = self._parts("nulls", NULLS)
        hashes = self.manifest("networks").select("network_id", "hash") if networks is None else network_hash(networks)
        foreign = self.manifest("nulls").select("network_id", F.col("hash").alias("made_on")).distinct().join(hashes, "network_id")
        if foreign.where("hash <> made_on").take(1):
            raise ValueError("stored experiments were made on other networks")
        return found.join(F.broadcast(hashes.select("network_id")), "network_id", "left_semi").drop("network_hash")

    def add_nulls(self, enriched: DataFrame) -> None:
        """Random experiments of mixes and sizes over networks of the store."""
        part = uuid.uuid4().hex
        rows = enriched.join(F.broadcast(self.manifest("networks").select("network_id", F.col("hash").alias("network_hash"))), "network_id")
        rows.select(*(c.split()[0] for c in NULLS.split(", "))).write.parquet(f"{self.folder}/nulls/{part}")
        written = self.spark.read.schema(NULLS).parquet(f"{self.folder}/nulls/{part}")
        done = written.select("network_id", F.col("network_hash").alias("hash"), "mix", "size").distinct()
        self._commit("nulls", done.withColumn("part", F.lit(part)))

    def lacking(self, sizes: list[int], mixes: list[str]) -> dict[tuple[int, ...], list[tuple[str, int]]]:
        """For sets of network ids the mixes and sizes that they have no experiments of."""
        have = {(r.network_id, r.mix, r.size) for r in self.manifest("nulls").collect()}
        ids = sorted(r[0] for r in self.manifest("networks").select("network_id").distinct().collect())
        out: dict[tuple[int, ...], list[tuple[str, int]]] = {}
        for mix in mixes:
            for size in sizes:
                if some := tuple(i for i in ids if (i, mix, size) not in have):
                    out.setdefault(some, []).append((mix, size))
        return out

    def unique_id(self) -> str:
        """A name for the networks as a whole."""
        rows = self.manifest("networks").select(F.concat_ws(":", "network_id", "hash").alias("e"))
        return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("e")), ","), 256)).first()[0]

    def save_information(self, params: Params, date: str, kinase_size: int, site_limit: int, by_compendia: bool, compendia_sizes: list[int]) -> None:
        """Run information as text, which `readers.run_information` reads."""
        many = self.manifest("networks").select("network_id").distinct().count()
        values = {"unique_id": self.unique_id(), "date": date, "network_used": "weighted", "phospho_type": params.phospho_type, "kinase_size": kinase_size, "site_limit": site_limit, "networks": many, "use_compendia": by_compendia}
        lines = [f"{RUN_FIELDS[k]}: {v}" for k, v in values.items()] + [f"Compendia {k}: {n}" for k, n in enumerate(compendia_sizes)]
        self.spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/information")
