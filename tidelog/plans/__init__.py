"""The store on Parquet and the command facade."""
