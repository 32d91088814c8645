"""The session helpers where nothing presets a checkpoint folder."""

import os
import subprocess
import sys

SCRIPT = """
from folioframe.session import checkpoint_dir, cut_lineage, local_session
spark = local_session(1, 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
path = checkpoint_dir(spark)
assert path == checkpoint_dir(spark)
assert cut_lineage(spark.range(3)).count() == 3
print("ok", path)
"""


def test_without_a_preset_checkpoint_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_HOME",)} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0 and "ok" in done.stdout, done.stderr[-2000:]
