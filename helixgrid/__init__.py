"""helixgrid: sequencing quality control as Spark DataFrame operators."""
