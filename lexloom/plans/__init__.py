"""The query catalogue: name -> plan over a table folder, and its SQL."""
