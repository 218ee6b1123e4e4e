"""Indexes in a database, by JDBC: written to staging tables and put in place in one transaction, read back in partitions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PARTS, TABLES, columns
from .store import Store

#: Values of the column that tables are read in partitions by.
SPREAD = 64
REPOSITORIES = "repo_id string, root_path string, last_indexed_at string, embedding_model string, dimension int"
#: Columns that rows are chosen by; databases that write text as large objects do not compare those.
KEYS = "repo_id VARCHAR(1000)"


def _rows(store: Store, repo_id: str, name: str) -> DataFrame:
    """A table of the index as the database has it: vectors as text like [0.5,1.0], which vector columns read, and `spread`."""
    if name == "repositories":
        info = store.get_repository(repo_id)
        found = store.spark.createDataFrame([(repo_id, info.root_path, info.last_indexed_at, info.embedding_model, info.dimension)], REPOSITORIES)
    else:
        found = store.table(repo_id, name)
    if name == "chunks":
        found = found.withColumn("vector", F.concat(F.lit("["), F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), F.lit("]")))
    return found.withColumn("spread", F.pmod(F.xxhash64(*[c for c in found.columns if c != "vector"]), F.lit(SPREAD)).cast("int"))


def _quoted(spark: SparkSession, url: str, *names: str) -> list[str]:
    """Names of columns as the database's own dialect quotes them, which is how Spark made them."""
    dialect = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    return [dialect.quoteIdentifier(n) for n in names]


def _connected(spark: SparkSession, url: str, properties: Mapping[str, str]):
    jvm = spark.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    return jvm.java.sql.DriverManager.getConnection(url, given)


def export(store: Store, repo_id: str, url: str, prefix: str = "flow_", properties: Mapping[str, str] | None = None) -> None:
    """Put a repository's index in the place of what the database has of it; other repositories' rows stay.

    Executors write staging tables, `prefix`, the table's name and `_new`. Then one transaction deletes the repository's rows and
    inserts the staged ones, so that readers see the old index or the new one, and a failure leaves the old. ValueError without an index.
    """
    properties = dict(properties or {})
    if store.get_repository(repo_id) is None:
        raise ValueError(f"{repo_id} has no index")
    names = ["repositories", *PARTS]
    for name in names:
        rows = _rows(store, repo_id, name)
        rows.write.mode("overwrite").option("createTableColumnTypes", KEYS).jdbc(url, f"{prefix}{name}_new", properties=properties)
        # the first export of any repository makes the tables
        rows.where("false").write.mode("append").option("createTableColumnTypes", KEYS).jdbc(url, f"{prefix}{name}", properties=properties)
    connection = _connected(store.spark, url, properties)
    try:
        connection.setAutoCommit(False)
        for name in names:
            own = columns(name) if name in TABLES else [c.split()[0] for c in REPOSITORIES.split(", ")]
            given = ", ".join(_quoted(store.spark, url, *own, "spread"))
            gone = connection.prepareStatement(f"DELETE FROM {prefix}{name} WHERE {_quoted(store.spark, url, 'repo_id')[0]} = ?")
            gone.setString(1, repo_id)
            gone.executeUpdate()
            connection.createStatement().executeUpdate(f"INSERT INTO {prefix}{name} ({given}) SELECT {given} FROM {prefix}{name}_new")
        connection.commit()
        for name in names:
            connection.createStatement().executeUpdate(f"DROP TABLE {prefix}{name}_new")
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def read(spark: SparkSession, url: str, name: str, repo_id: str, prefix: str = "flow_", properties: Mapping[str, str] | None = None, parts: int = 8) -> DataFrame:
    """A table of a repository's index in the database, read by `parts` tasks."""
    own = f"(SELECT * FROM {prefix}{name} WHERE {_quoted(spark, url, 'repo_id')[0]} = '{repo_id.replace(chr(39), chr(39) * 2)}') q"
    found = spark.read.jdbc(url, own, column="spread", lowerBound=0, upperBound=SPREAD, numPartitions=parts, properties=dict(properties or {}))
    found = found.drop("spread")
    if name == "chunks":
        numbers = F.split(F.regexp_replace("vector", r"[\[\]\s]", ""), ",")
        found = found.withColumn("vector", F.transform(F.filter(numbers, lambda x: x != ""), lambda x: x.cast("float")))
    return found


def load(store: Store, repo_id: str, url: str, prefix: str = "flow_", properties: Mapping[str, str] | None = None, parts: int = 8) -> None:
    """Make what the database has of a repository its index in `store`; ValueError if it has none. The facts of its files are not there: reindexing begins anew."""
    known = read(store.spark, url, "repositories", repo_id, prefix, properties, 1).first()
    if known is None:
        raise ValueError(f"the database has no index of {repo_id}")
    tables = {n: read(store.spark, url, n, repo_id, prefix, properties, parts) for n in PARTS}
    store.replace(repo_id, known["root_path"], tables, known["embedding_model"], known["dimension"])
