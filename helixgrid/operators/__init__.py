"""helixgrid.operators"""
