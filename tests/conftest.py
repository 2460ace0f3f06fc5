import pytest
from pyspark.sql import SparkSession

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("claimcheck-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def orders(spark):
    return spark.read.parquet(f"{TESTDATA}/sf0.001/orders.parquet")


@pytest.fixture(scope="session")
def churn(spark):
    """7,043 customers with the published counts: 1,869 churned, 3,875 month-to-month (1,655 churned)."""
    return spark.sql(
        """
        SELECT id AS customerID,
          CASE WHEN id < 3875 THEN 'Month-to-month' WHEN id % 2 = 0 THEN 'Two year' ELSE 'One year' END AS Contract,
          CASE WHEN id < 1655 OR (id >= 3875 AND id < 3875 + 214) THEN 'Yes' ELSE 'No' END AS Churn,
          CASE WHEN id < 1142 THEN 1 ELSE 0 END AS SeniorCitizen,
          CASE WHEN id % 9 < 4 AND id < 6966 THEN 'Fiber optic' ELSE 'DSL' END AS InternetService,
          CASE WHEN id >= 7032 THEN 0 ELSE CAST(id % 72 + 1 AS INT) END AS tenure,
          20.0D + id % 90 + CASE WHEN id % 9 < 4 AND id < 6966 THEN 30.25D ELSE 0.0D END AS MonthlyCharges,
          CASE WHEN id >= 7032 THEN ' ' ELSE CAST(id * 1.5D AS STRING) END AS TotalCharges
        FROM range(7043)
        """
    ).cache()
