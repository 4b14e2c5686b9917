"""curbside: live spatial matching of moving taxis and waiting clients on PySpark."""
