import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cytoweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def vectors(spark):
    """Build (cell_id, vec, ...) tables from numpy rows."""

    def build(matrix, **columns):
        rows = [
            (int(i), [float(v) for v in row], *[columns[c][i] for c in columns]) for i, row in enumerate(matrix)
        ]
        types = {int: "bigint", str: "string", float: "double"}
        extra = "".join(f", {c} {types[type(v[0])]}" for c, v in columns.items())
        return spark.createDataFrame(rows, f"cell_id bigint, vec array<double>{extra}")

    return build
