import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Written tables of these tests go to one folder."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
