"""name -> DuckDB SQL for the registered queries."""

from oracle import payments, reports, texts

ORACLE = {**payments.SQL, **reports.SQL, **texts.SQL}
