"""Training-data operators: each module holds one operator, ``registry`` the queries over the driver's tables."""
