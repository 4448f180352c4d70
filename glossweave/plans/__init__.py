"""Multi-table jobs: partition layout, quality checks, driver-table adapters."""
