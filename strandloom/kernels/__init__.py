"""Graph and sequence kernels in plain Python, tested without Spark; grouped functions run them on executors."""
