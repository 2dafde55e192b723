"""capturelake: free-text capture analytics as Spark DataFrame jobs."""
