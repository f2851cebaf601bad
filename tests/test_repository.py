"""Rules the library keeps: no local checkpoints, no Python row functions, no driver-sized collects in operators."""

from pathlib import Path

PACKAGE = Path(__file__).resolve().parents[1] / "caseloom"


def test_no_forbidden_calls():
    for path in PACKAGE.rglob("*.py"):
        text = path.read_text()
        for call in ("localCheckpoint", "toPandas(", ".rdd", "F.udf(", "toLocalIterator", "coalesce(1)"):
            assert call not in text, f"{call} in {path}"
