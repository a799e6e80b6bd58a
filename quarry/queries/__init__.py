"""One registered query for each operator, function group and source, with its oracle."""
