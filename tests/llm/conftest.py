import pytest


@pytest.fixture(scope="session")
def sf_dir():
    """These tables hold secrets, personal data, labels of all kinds and benchmark passages."""
    return "/root/testdata/sf0.01"
