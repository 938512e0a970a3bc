"""Plan shapes shared by the jobs: size checks, order buckets, hot keys."""
