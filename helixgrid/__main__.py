from helixgrid.commands import main

main()
