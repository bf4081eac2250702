"""Views over the star schema, and the queries that exercise the operators on them."""
