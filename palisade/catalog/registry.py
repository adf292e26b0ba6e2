"""How a query is registered and presented."""

from pyspark.sql import DataFrame, functions as F, types as T

from palisade.session import ship_package

DIGITS = 6  # doubles of a result are rounded to this many digits
QUERIES: dict = {}
ORACLES: dict = {}


def present(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded and times without a zone, so that results of two engines can be compared."""
    columns = []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # adding zero turns -0.0 into 0.0
            columns.append((F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(field.name))
        elif isinstance(field.dataType, T.TimestampType):
            columns.append(F.col(name).cast("timestamp_ntz").alias(field.name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)




def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL twin if there is one."""

    def register(build):
        def run(spark, sf_dir):
            ship_package(spark)
            return present(build(spark, sf_dir), digits)

        run.__name__, run.__doc__ = name, build.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r(expression: str, alias: str, digits: int = DIGITS) -> str:
    """SQL text of a rounded double column."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {alias}"
