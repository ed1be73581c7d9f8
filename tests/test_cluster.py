"""What only a session of several processes shows."""

import os
import subprocess
import sys
import textwrap

import pyspark

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def on_cluster(tmp_path, code):
    """Run code with ``spark`` being a session of two executors in processes of their own; what it prints."""
    home, spark_home = tmp_path / "home", os.path.dirname(pyspark.__file__)
    (home / "work").mkdir(parents=True)  # the executors' logs
    for name in set(os.listdir(spark_home)) - {"work"}:
        (home / name).symlink_to(f"{spark_home}/{name}")
    start = f"""
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.config(map={{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "2",
            "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}).getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
    """
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": REPO}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(start) + textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_a_database_in_the_drivers_process(tmp_path):
    out = on_cluster(
        tmp_path,
        """
        import __spark_entry__ as entry
        from quern.operators import loads
        from quern.sources import connections, files
        print(entry.queries()["source_jdbc"](spark, "/root/testdata/sf0.001").orderBy("n_nationkey").collect()[4:6])
        files.ROWS_AT_ONCE = 3  # several at once
        c = connections.Connection("jdbc", {"url": "jdbc:derby:memory:t;create=true"})
        files.connect(spark, c.jdbc_url, {}).createStatement().executeUpdate('CREATE TABLE t ("id" INT PRIMARY KEY, "v" DOUBLE, "at" TIMESTAMP, "s" VARCHAR(9))')
        make = "SELECT CAST(id AS INT) AS id, id / 2 AS v, timestamp_seconds(id) AS at, nullif(CAST(id AS STRING), '6') AS s FROM range({})"
        loads.write_spark_df(spark.sql(make.format(8)), c, "t")
        loads.write_spark_df(spark.sql(make.format(0)), c, "t")
        rows = files.query(spark, c.jdbc_url, "SELECT * FROM t", partition=("id", 0, 8, 2))
        print(rows.count(), rows.exceptAll(spark.sql(make.format(8))).count(), files.query(spark, c.jdbc_url, "SELECT * FROM t WHERE \\"id\\" > 90").count())
        """,
    )
    assert out.split("\n")[:2] == ["[Row(n_nationkey=4, n_name='NATION_4'), Row(n_nationkey=5, n_name='NATION_5!')]", "8 0 0"]
