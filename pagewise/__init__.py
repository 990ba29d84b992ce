"""pagewise: paged vector data, page selection and long-text evaluation on Spark."""
