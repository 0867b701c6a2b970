import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
# the workers import the package too
os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *os.environ.get("PYTHONPATH", "").split(os.pathsep)])).rstrip(os.pathsep)
