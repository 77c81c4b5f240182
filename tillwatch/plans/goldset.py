"""The twelve reference questions as Spark SQL over one ``tickets`` view; ties are broken by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUESTIONS = {
    "gold_q01": "SELECT COUNT(*) AS attempts FROM tickets",
    "gold_q02": "SELECT COUNT(DISTINCT customer_id) AS customers FROM tickets",
    "gold_q03": "SELECT AVG(CAST(is_success AS INT)) AS success_rate FROM tickets WHERE year = {year}",
    "gold_q04": "SELECT paying_method FROM tickets GROUP BY paying_method "
                "ORDER BY 1 - AVG(CAST(is_success AS INT)) DESC, paying_method LIMIT 1",
    "gold_q05": "SELECT description FROM tickets WHERE NOT is_success GROUP BY description "
                "ORDER BY COUNT(*) DESC, description LIMIT 1",
    "gold_q06": "SELECT CAST(ROUND(SUM(CAST(final_price AS DECIMAL(18,4))), 2) AS DOUBLE) AS revenue FROM tickets "
                "WHERE is_success AND year = {previous}",
    "gold_q07": "SELECT movie_name FROM tickets WHERE is_success GROUP BY movie_name ORDER BY COUNT(*) DESC, movie_name LIMIT 1",
    "gold_q08": "SELECT year_month FROM tickets GROUP BY year_month ORDER BY COUNT(*) DESC, year_month LIMIT 1",
    "gold_q09": "SELECT COUNT(*) AS external_errors FROM tickets WHERE year = {year} AND error_group = 'external'",
    "gold_q10": "SELECT campaign_type FROM tickets WHERE is_success AND type = 'promotion' GROUP BY campaign_type "
                "ORDER BY COUNT(*) DESC, campaign_type LIMIT 1",
    "gold_q11": "SELECT platform, 1 - AVG(CAST(is_success AS INT)) AS failure_rate FROM tickets "
                "WHERE platform IN ('mobile', 'website') GROUP BY platform",
    "gold_q12": "SELECT day_name FROM tickets WHERE is_success GROUP BY day_name ORDER BY COUNT(*) DESC, day_name LIMIT 1",
}


def ask(spark: SparkSession, tickets: DataFrame, name: str, year: int, max_rows: int | None = None) -> DataFrame:
    """The answer to a question, whole unless ``max_rows`` asks for a short one to show."""
    tickets.createOrReplaceTempView("tickets")
    sql = QUESTIONS[name].format(year=year, previous=year - 1)
    answer = spark.sql(sql)
    return answer if max_rows is None else answer.limit(max_rows)
