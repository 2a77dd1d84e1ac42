"""The access functions as native SQL functions of a session.

``register_access_functions`` binds a grants table and an accounts table as
temp views and creates, as temporary SQL functions (no Python involved):

* ``has_app_access(app)``, ``app_role(app)``, ``is_platform_admin()`` — read
  the session variable ``caller`` (null = nobody signed in);
* ``list_app_users()`` — a table function: all accounts for a platform
  admin, an empty set for anyone else.

Spark treats a function argument as an outer reference, so a call in a
WHERE clause is decorrelated into a broadcast join with the caller's own
grants: at most one row per app, whatever the size of the governed table.
(The DataFrame operators in ``tessera.operators.access`` plan the same
decision as a subquery evaluated once.) Policies can then be written as plain SQL, e.g.
``SELECT * FROM t WHERE has_app_access('view') AND (app_role('view') =
'app_admin' OR owner_id = caller)``. A DataFrame binds the variable's value
when it is created (analysis time), so set the caller first. The functions
read the grants view at query time: a new grants version registered under
the same view name applies to the next query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GRANTS_VIEW = "app_access"
ACCOUNTS_VIEW = "app_users"


def register_access_functions(spark: SparkSession, grants: DataFrame, accounts: DataFrame | None = None,
                              user_type: str = "BIGINT") -> None:
    grants.createOrReplaceTempView(GRANTS_VIEW)
    spark.sql(f"DECLARE OR REPLACE VARIABLE caller {user_type} DEFAULT NULL")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION has_app_access(app_name STRING) RETURNS BOOLEAN
        RETURN (SELECT count(1) > 0 FROM {GRANTS_VIEW} WHERE user_id = caller AND app = app_name)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION app_role(app_name STRING) RETURNS STRING
        RETURN (SELECT role FROM {GRANTS_VIEW} WHERE user_id = caller AND app = app_name)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION is_platform_admin() RETURNS BOOLEAN
        RETURN (SELECT count(1) > 0 FROM {GRANTS_VIEW}
                WHERE user_id = caller AND app = 'platform' AND role = 'app_admin')""")
    if accounts is not None:
        accounts.createOrReplaceTempView(ACCOUNTS_VIEW)
        ts = dict(accounts.dtypes).get("created_at", "timestamp_ntz")
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION list_app_users()
            RETURNS TABLE (id {user_type}, email STRING, created_at {ts}, last_sign_in_at {ts})
            RETURN SELECT user_id, email, created_at, last_sign_in_at FROM {ACCOUNTS_VIEW}
                   WHERE is_platform_admin() ORDER BY email""")


def set_caller(spark: SparkSession, caller) -> None:
    """Sign in as ``caller`` (None: nobody) for DataFrames created from now on."""
    spark.sql("SET VARIABLE caller = :c", args={"c": caller})
