"""Writers of reports. They take small, aggregated results; large ones are written by Spark itself (write_frame)."""
