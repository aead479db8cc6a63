"""The jobs as queries over the whole tables, with DuckDB SQL for their output."""

from __future__ import annotations

from jobs.session_dataset import JOB1_SQL, job1_session_dataset
from jobs.text_audit import JOB2_SQL, job2_text_audit

QUERIES = {"job1_session_dataset": job1_session_dataset, "job2_text_audit": job2_text_audit}
SQL = {"job1_session_dataset": JOB1_SQL, "job2_text_audit": JOB2_SQL}
