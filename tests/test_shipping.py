import io
import subprocess
import sys
import zipfile
from pathlib import Path

from counterpoise.shipping import package_zip

ROOT = Path(__file__).resolve().parent.parent


def test_zip_holds_the_sources_and_is_reproducible():
    one, two = package_zip(), package_zip()
    assert one == two
    names = zipfile.ZipFile(io.BytesIO(one)).namelist()
    assert "counterpoise/__init__.py" in names and "counterpoise/operators/smote.py" in names


def test_queries_run_from_another_folder(tmp_path, sf):
    """Workers find the package though it is on the driver's path only."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.queries()["smote_neighbors"](spark, {sf!r}).limit(5).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=280)
    assert "rows 5" in done.stdout, done.stderr[-2000:]
