import subprocess
import sys

from test_queries import ROOT

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
assert __spark_entry__.queries()["gram"](spark, {data!r}).count() == 100
"""


def test_workers_get_the_package_when_their_path_lacks_it(small, tmp_path):
    env = {"PATH": "/usr/local/bin:/usr/bin:/bin", "HOME": str(tmp_path)}
    import os

    env |= {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "PATH", "SPARK_LOCAL_IP")}
    subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), data=small)], cwd=tmp_path, check=True, env=env, timeout=300)
