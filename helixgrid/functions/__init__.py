"""helixgrid.functions"""
