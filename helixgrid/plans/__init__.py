"""helixgrid.plans"""
