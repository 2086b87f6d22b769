"""Scratch tables: what `materialize` leaves on disk."""

import os
import subprocess
import sys


def test_materialize_deletes_its_shuffle_files(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import glob, time
from pyspark.sql import functions as F
from shelfline.session import FREE_SHUFFLES, get_spark, materialize
s = get_spark('local[2]', shuffle_partitions=4, extra={{'spark.local.dir': {str(tmp_path)!r}, 'spark.driver.memory': '1g'}})
rows = s.range(1000).repartition(4, 'id')
shuffles = lambda: set(glob.glob({str(tmp_path)!r} + '/**/shuffle_*', recursive=True))
rows.write.format('noop').mode('overwrite').save()
plain = shuffles()          # of a write of its own, left to the garbage collector
table = materialize(rows.groupBy((F.col('id') % 7).alias('k')).count(), 't')
until = time.time() + 30                         # executors delete them in the background
while shuffles() - plain and time.time() < until:
    time.sleep(0.2)
print('LEFT', len(plain) > 0, len(shuffles() - plain), sum(r['count'] for r in table.collect()), rows.count(),
      s.conf.get(FREE_SHUFFLES, None))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=300)
    assert "LEFT " in out.stdout, out.stderr[-2000:]
    assert out.stdout.split("LEFT ")[1].split() == ["True", "0", "1000", "1000", "None"]
