import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] in BLOCKED or name in BLOCKED:
            raise ModuleNotFoundError('No module named ' + name, name=name)
BLOCKED = set(sys.argv[1].split(','))
sys.meta_path.insert(0, Block())
sys.path.insert(0, ROOT)
import __spark_entry__ as e
names = set(e.queries())
print(len(names), 'pipeline' in names, any(n.startswith('op') and n[2].isdigit() for n in names), set(e.oracle_sql()) <= names)
"""


def run(blocked):
    done = subprocess.run([sys.executable, "-c", CODE.replace("ROOT", repr(ROOT), 1), blocked], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_core_queries_need_no_optional_package():
    for blocked in ("xxhash", "tokenizers,public_tokenizers", "curata.llm,corpus_pipeline"):
        n, pipeline, numbered, oracles = run(blocked)
        assert int(n) >= 100 and pipeline == "False" and numbered == "False" and oracles == "True"
