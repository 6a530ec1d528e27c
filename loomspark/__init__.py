"""loomspark: prompt-routing analytics and corpus operators on PySpark."""
