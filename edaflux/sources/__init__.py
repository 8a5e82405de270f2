"""Reading and writing the tables of the forecasting workflow."""
