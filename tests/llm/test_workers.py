"""Functions and classes that tasks run load in a process without the package."""

import importlib
import os
import pkgutil
import subprocess
import sys

from pyspark import cloudpickle

import feedpulse

LOADER = """
import pickle, sys
bad = []
with open(sys.argv[1], "rb") as f:
    for name, data in pickle.load(f):
        try:
            pickle.loads(data)
        except ModuleNotFoundError as e:
            bad.append(f"{name}: {e}")
print("\\n".join(bad))
"""


def test_everything_travels_by_value(tmp_path):
    import pickle
    parts = []
    for _, name, _ in pkgutil.walk_packages(feedpulse.__path__, "feedpulse."):
        module = importlib.import_module(name)
        for key, value in vars(module).items():
            if callable(value) and getattr(value, "__module__", None) == name:
                parts.append((f"{name}.{key}", cloudpickle.dumps(value)))
    assert len(parts) > 200
    (tmp_path / "parts").write_bytes(pickle.dumps(parts))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", LOADER, str(tmp_path / "parts")], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == ""
