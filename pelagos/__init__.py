"""Maritime decision analytics and training-data operators on Spark."""
