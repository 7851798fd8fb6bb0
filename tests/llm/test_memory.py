import subprocess
import sys

CODE = """
from tideline.llm import common
held = []
def run(it):
    held.extend(bytes(1000) for _ in range(300_000))  # too small to be given back one by one
    last = bytes(1000)
    held.clear()
    keep.append(last)
    yield from it
keep = []
common.RESTING = 0
assert list(common.tidy(run)([1, 2])) == [1, 2]
after = common.own_mb()
assert after < 150, after
try:
    list(common.tidy(lambda it: (1 / 0 for _ in it))([1]))
except ZeroDivisionError:
    print("raised")
"""


def test_a_worker_gives_back_what_a_task_has_freed():
    got = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, timeout=60)
    assert got.stdout.strip() == "raised", got.stderr
