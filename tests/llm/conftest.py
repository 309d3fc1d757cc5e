import os

import pytest

SF = os.environ.get("LECTERN_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
