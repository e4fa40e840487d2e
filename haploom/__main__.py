from haploom.plans.run import main

main()
